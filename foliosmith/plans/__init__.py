"""Plans: whole documents from page output, configuration, inference, and the registered queries."""
