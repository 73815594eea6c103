"""Tables, layers and files that operators read and write."""
