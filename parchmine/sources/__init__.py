"""Files and input tables as frames, and frames as files."""
