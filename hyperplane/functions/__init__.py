"""Column functions over dense vectors (arrays of doubles), and kernels over pairs of them."""
