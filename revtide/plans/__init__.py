"""Physical-shape helpers shared by the operators, and the end-to-end jobs built on them."""
