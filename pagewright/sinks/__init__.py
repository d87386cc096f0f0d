"""Writers of result tables: JSON lines, thumbnails."""
