"""Readers and writers: mailbox dumps, JSON lines, the chunk store."""
