"""DataFrame operators: filter, group, rank, bin, pivot, order, facet."""
