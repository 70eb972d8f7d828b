"""Streaming counterparts of the watcher, the queue consumer and the leases."""
