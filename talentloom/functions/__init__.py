"""Column functions over text, dates, ladders and vectors."""
