"""Operators over growing inputs."""
