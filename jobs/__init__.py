"""Jobs that run the library over tables and keep their output."""
