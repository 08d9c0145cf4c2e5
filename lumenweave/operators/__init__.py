"""DataFrame-to-DataFrame operators on pixels, libraries, points and rasters."""
