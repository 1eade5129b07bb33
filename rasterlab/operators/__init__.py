"""DataFrame-to-DataFrame operators over pixels, cells, masks and tracks."""
