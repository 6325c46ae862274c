"""Writers that check first: see files."""
