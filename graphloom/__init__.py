"""graphloom: code-intelligence graph analytics and corpus processing as DataFrame operators."""
