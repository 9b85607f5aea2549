"""The stateless row transforms run as a resumable stream."""
