"""Registered queries: every operator run over the driver tables, each with its SQL twin."""
