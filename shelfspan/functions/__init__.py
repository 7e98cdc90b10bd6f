"""Column functions shared by readers and plans."""
