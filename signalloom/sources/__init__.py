"""Readers and writers of signal, cluster, host and scrape data."""
