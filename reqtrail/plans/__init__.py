"""Stages made of operators, and the queries of the driver."""
