"""Reading and checking of spatial tables, and writing of draws."""
