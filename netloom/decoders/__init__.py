"""Decoders: tables of streams in, tables of messages out."""
