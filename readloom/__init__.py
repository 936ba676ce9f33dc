"""Demultiplexing of combinatorial barcodes in sequencing reads, as DataFrame operations."""
