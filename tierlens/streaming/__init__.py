"""Long scoring runs that continue where they stopped."""
