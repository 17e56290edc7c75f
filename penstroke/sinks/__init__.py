"""Writers: profiles as JSON, reports as Markdown."""
