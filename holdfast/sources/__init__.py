"""Where rows come from and go to: bindings, CSV, the score store, saved models."""
