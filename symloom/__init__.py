"""symloom: symbol-table work over large corpora of JavaScript source, as Spark jobs."""
