"""Sources: directory listings, binary image files, manifests."""
