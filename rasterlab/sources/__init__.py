"""Image and mask files, file catalogues and result sinks."""
