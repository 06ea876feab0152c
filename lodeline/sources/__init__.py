"""Reading and writing of objects and packages."""
