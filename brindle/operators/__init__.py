"""Operators that are more than one DataFrame call: joins in time, keyed tables, sequence logs, frames."""
