"""Hidden Markov models: numpy estimators that run inside tasks."""
