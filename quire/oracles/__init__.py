"""DuckDB SQL of the operators that are written as functions of DataFrames, made apart from them from the rules alone."""
