"""The library's operators over streams of files."""
