"""Batch builds: tables that several steps read, and a corpus folder with its indexes."""
