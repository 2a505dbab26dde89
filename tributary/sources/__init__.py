"""Sources: tables, change logs, raw record lines, edit and story feeds, generators and node logs."""
