"""Multi-operator jobs: panel build, training and scoring."""
