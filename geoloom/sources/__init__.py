"""Tables, files and the adapter for the driver's test tables."""
