"""What is detected and in which order, worked out on the driver."""
