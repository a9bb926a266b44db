"""The engine that ties tables and operators together."""
