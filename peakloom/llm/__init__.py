"""Training-data operators: ten corpus operations, each usable on any table with an id and a text column."""
