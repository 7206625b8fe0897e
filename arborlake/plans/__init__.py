"""Plan builders: reusable shapes of joins, groupings and windows."""
