"""Streams into vector tables, and standing nearest-neighbour queries over them."""
