"""Plan helpers shared by the operators, and the registered queries."""
