"""Views over stored tables in the shapes the operators take."""
