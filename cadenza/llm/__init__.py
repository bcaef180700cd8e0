"""Training-data operators on Spark (see the README section "Training-data operators")."""
