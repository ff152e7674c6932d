"""Operators: data frames in, a data frame out. None collects rows to the driver."""
