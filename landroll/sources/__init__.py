"""Readers and writers of the files the jobs work on."""
