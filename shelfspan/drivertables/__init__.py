"""The sample tables read as capacity sources, and the named queries over them."""
