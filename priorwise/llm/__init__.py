"""Training-data operators over large document tables. Nothing else in the package imports this folder."""
