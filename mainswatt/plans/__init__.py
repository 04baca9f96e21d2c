"""Training and prediction, composed of operators."""
