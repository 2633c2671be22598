"""Front end: preprocessing, parsing, components, types and static checks of programs."""
