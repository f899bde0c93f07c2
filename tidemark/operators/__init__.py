"""DataFrame-to-DataFrame operators; lazy, parameters explicit, all areas at once."""
