"""Jobs that put the library to work on tables; each module runs from a command line."""
