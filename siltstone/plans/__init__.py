"""Query plans over tables of a made-up code base."""
