"""Relational operators over spatio-textual frames."""
