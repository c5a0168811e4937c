"""Jobs that run by themselves on given tables: python -m jobs.<name> --help."""
