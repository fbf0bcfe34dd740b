"""Stateful streaming operators, each equal to a batch operator once its input ends."""
