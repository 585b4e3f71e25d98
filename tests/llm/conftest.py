"""The session and the test tables are those of tests/conftest.py."""
