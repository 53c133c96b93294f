"""Website audits as DataFrame queries."""
