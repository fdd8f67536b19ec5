"""The DEX binary format: numbers, strings, opcodes, instructions, whole images."""
