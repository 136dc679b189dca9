"""Where rows come from: watched folders, file checks, recognised text, model answers."""
