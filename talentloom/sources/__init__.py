"""Reading, checking and storing documents and profiles."""
