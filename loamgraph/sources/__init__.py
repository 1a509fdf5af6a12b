"""Readers for the engine's inputs."""
