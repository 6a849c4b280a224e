"""Part of gridloom; see the modules."""
