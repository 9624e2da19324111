"""Profiles of growing inputs."""
