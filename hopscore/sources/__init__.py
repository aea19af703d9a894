"""Sources and sinks: question files, result tables, graphs, graph schemas, training examples."""
