"""Small NumPy encoders with a tape of gradients, low-rank adapters and their trainer. Optional: nothing distributed depends on them."""
