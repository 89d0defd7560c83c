"""Set-at-a-time operators: frames in, frames out."""
