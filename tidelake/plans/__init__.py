"""The Silver and Gold datasets and the checks that belong to them."""
