"""Neural networks: numpy in the workers, gradients added up by Spark."""
