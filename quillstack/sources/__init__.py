"""Reading and writing annotations, manifests, listings and exports."""
