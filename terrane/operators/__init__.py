"""Set-shaped operators over locations, neighbours, factors, outcomes and draws."""
