"""The stateless stages and static joins on streams."""
