"""HTTP and command-line surface; handlers don't know the transport."""
