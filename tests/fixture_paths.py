"""Folders of the given tables; a module of its own, since two conftest.py share one module name."""

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"
