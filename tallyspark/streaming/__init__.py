"""The batch plan over streams of files."""
