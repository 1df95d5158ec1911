"""Jobs with a command line and a config file, made of the library's operators."""
