"""A PySpark-native capture analytics engine: packets in, counters, flows and tunnels out."""
