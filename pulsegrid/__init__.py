"""pulsegrid: CI test-stability analytics and corpus preparation on Spark."""
