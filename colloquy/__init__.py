"""Conversation and corpus analytics as Spark DataFrame transformations."""
