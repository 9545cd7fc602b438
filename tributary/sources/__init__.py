"""Readers and writers of semi-structured inputs."""
